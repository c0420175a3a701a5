"""Sources and sinks (S*) and the test-table views."""
