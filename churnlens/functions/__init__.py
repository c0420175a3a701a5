"""Column builders (scalar functions F*, predicates P*)."""
