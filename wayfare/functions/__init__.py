"""Column expressions: no I/O, no Python UDFs, safe under ANSI and any time zone."""
