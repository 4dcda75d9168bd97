"""The operators run over the benchmark tables, each with the SQL it equals."""
