"""Codebase analytics over tables of files and commits, as Spark DataFrame operators."""
