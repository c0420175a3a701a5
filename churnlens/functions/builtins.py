"""Builtin function names per language (X15), as a small static dimension.

Written from the public language references (standard library / builtin
function indexes), not probed from installed interpreters, so the table is
the same on every machine.
TypeScript uses the JavaScript set; an unknown language has no builtins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BUILTINS: dict[str, list[str]] = {
    "php": """array list echo print die exit empty isset unset eval include require include_once require_once
        strlen strtolower strtoupper substr strpos stripos strrpos str_replace str_ireplace str_repeat str_pad
        str_split str_contains str_starts_with str_ends_with trim ltrim rtrim explode implode join sprintf printf
        vsprintf number_format ucfirst ucwords lcfirst nl2br htmlspecialchars htmlentities html_entity_decode
        strip_tags addslashes stripslashes md5 sha1 crc32 hash base64_encode base64_decode urlencode urldecode
        rawurlencode json_encode json_decode serialize unserialize var_dump var_export print_r count sizeof
        in_array array_key_exists array_keys array_values array_merge array_map array_filter array_reduce
        array_slice array_splice array_push array_pop array_shift array_unshift array_search array_unique
        array_reverse array_combine array_flip array_fill array_column sort rsort usort ksort krsort asort arsort
        uasort uksort range compact extract is_array is_string is_int is_integer is_numeric is_bool is_null
        is_object is_callable is_float intval floatval strval boolval settype gettype get_class method_exists
        property_exists function_exists class_exists defined define constant call_user_func call_user_func_array
        func_get_args preg_match preg_match_all preg_replace preg_replace_callback preg_split preg_quote
        file_get_contents file_put_contents fopen fclose fread fwrite fgets file_exists is_file is_dir mkdir
        unlink rename copy dirname basename pathinfo realpath time date mktime strtotime microtime sleep usleep
        abs ceil floor round min max pow sqrt rand mt_rand random_int uniqid header setcookie session_start
        ob_start ob_get_clean error_log trigger_error set_error_handler spl_autoload_register exec mysqli_connect""".split(),
    "javascript": """parseInt parseFloat isNaN isFinite encodeURI encodeURIComponent decodeURI decodeURIComponent
        eval setTimeout setInterval clearTimeout clearInterval setImmediate queueMicrotask require alert confirm
        prompt fetch structuredClone atob btoa log warn error info debug push pop shift unshift slice splice
        concat join reverse sort indexOf lastIndexOf includes find findIndex filter map reduce reduceRight forEach
        some every keys values entries assign freeze create defineProperty getPrototypeOf toString valueOf
        hasOwnProperty charAt charCodeAt split substring substr toLowerCase toUpperCase trim replace replaceAll
        match matchAll startsWith endsWith padStart padEnd repeat then catch finally resolve reject all race
        stringify parse now floor ceil round abs max min random pow sqrt isArray from of bind call apply
        addEventListener removeEventListener querySelector querySelectorAll getElementById createElement
        appendChild setAttribute getAttribute Array Object String Number Boolean Symbol BigInt Map Set WeakMap WeakSet
        Promise Date RegExp Error Proxy Function""".split(),
    "python": """abs aiter all anext any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex
        delattr dict dir divmod enumerate eval exec filter float format frozenset getattr globals hasattr hash help
        hex id input int isinstance issubclass iter len list locals map max memoryview min next object oct open ord
        pow print property range repr reversed round set setattr slice sorted staticmethod str sum super tuple type
        vars zip __import__""".split(),
    "c": """printf fprintf sprintf snprintf scanf fscanf sscanf puts fputs gets fgets putchar getchar fopen fclose
        fread fwrite fseek ftell rewind fflush feof ferror perror remove rename tmpfile malloc calloc realloc free
        memcpy memmove memset memcmp memchr strlen strcpy strncpy strcat strncat strcmp strncmp strchr strrchr
        strstr strtok strdup strerror atoi atol atoll atof strtol strtoul strtoll strtod abs labs div rand srand
        qsort bsearch exit abort atexit getenv system assert isalpha isdigit isalnum isspace isupper islower
        toupper tolower time clock difftime mktime localtime gmtime strftime sqrt pow sin cos tan exp log log10
        floor ceil fabs fmod sizeof signal raise setjmp longjmp va_start va_arg va_end""".split(),
    "cpp": """printf fprintf sprintf snprintf scanf puts malloc calloc realloc free memcpy memmove memset memcmp
        strlen strcpy strncpy strcat strcmp strncmp strchr strstr atoi atof strtol exit abort getenv system assert
        sqrt pow sin cos exp log floor ceil fabs abs sizeof static_cast dynamic_cast reinterpret_cast const_cast
        typeid move forward swap make_shared make_unique make_pair make_tuple get tie begin end cbegin cend rbegin
        rend size empty push_back emplace_back pop_back push pop front back insert erase clear find count at data
        resize reserve substr c_str length append sort stable_sort min max min_element max_element accumulate
        transform copy fill reverse unique lower_bound upper_bound binary_search for_each getline to_string stoi
        stol stod cout cin cerr endl vector string map set unordered_map unordered_set pair tuple list deque queue
        stack array unique_ptr shared_ptr function optional variant""".split(),
    "csharp": """WriteLine Write ReadLine Read ToString Equals GetHashCode GetType Parse TryParse Format Concat Join
        Split Substring Replace Contains StartsWith EndsWith IndexOf Trim ToUpper ToLower Add Remove Clear
        Insert Count Any All Select Where First FirstOrDefault Last OrderBy OrderByDescending GroupBy ToList
        ToArray ToDictionary Sum Max Min Average Distinct Skip Take Dispose Close Flush nameof typeof sizeof
        Max Abs Floor Ceiling Round Sqrt Pow""".split(),
    "go": """append cap clear close complex copy delete imag len make max min new panic print println real recover
        Println Printf Sprintf Errorf Fprintf Fatal Fatalf""".split(),
    "java": """println print printf format toString equals hashCode getClass valueOf parseInt parseLong
        parseDouble length charAt substring indexOf contains startsWith endsWith split trim toUpperCase
        toLowerCase replace isEmpty size get put add remove clear containsKey keySet values entrySet iterator
        hasNext next stream map filter collect forEach sort asList of copyOf max min abs sqrt pow currentTimeMillis
        nanoTime arraycopy exit getMessage printStackTrace close append""".split(),
    "ruby": """puts print p pp require require_relative load raise fail loop lambda proc format sprintf printf gets
        rand srand sleep exit abort at_exit attr_accessor attr_reader attr_writer include extend private public
        protected each map select reject collect inject reduce each_with_index times upto downto to_s to_i to_f
        to_a to_h to_sym length size empty? nil? is_a? kind_of? respond_to? send freeze frozen? dup clone
        include? push pop shift unshift join split strip gsub sub upcase downcase chomp keys values merge fetch""".split(),
    "rust": """println! print! eprintln! eprint! format! vec! panic! assert! assert_eq! assert_ne! debug_assert!
        unreachable! unimplemented! todo! write! writeln! matches! dbg! include_str! env! concat! Some None Ok Err
        Box new clone to_string to_owned into from unwrap expect unwrap_or map and_then ok_or iter into_iter
        collect len is_empty push pop insert remove get contains as_str as_ref borrow drop default println print
        eprintln eprint format vec panic assert assert_eq assert_ne write writeln todo unimplemented""".split(),
}


LANGUAGE_SET = {"typescript": "javascript"}


def builtin_key_lang(lang: str) -> str:
    return LANGUAGE_SET.get(lang, lang)


def builtins_dim(spark: SparkSession) -> DataFrame:
    """(lang, name) rows for every language; TypeScript rows repeat the JavaScript set."""
    rows = sorted({(lang, name) for lang, names in BUILTINS.items() for name in names})
    rows += [(ts, name) for ts, src in LANGUAGE_SET.items() for (lang, name) in rows if lang == src]
    return spark.createDataFrame(rows, "lang string, name string")
