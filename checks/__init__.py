"""The library's operators run over the given star-schema tables, each with the same question in plain SQL."""
