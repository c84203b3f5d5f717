"""snipquarry: documentation and code-snippet analytics as Spark plans."""
