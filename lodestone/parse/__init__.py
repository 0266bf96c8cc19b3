"""Symbols and imports from source text: pure-Python lexing, run on executors in Arrow batches."""
