"""Relational operators that Spark lacks, composed of its own."""
