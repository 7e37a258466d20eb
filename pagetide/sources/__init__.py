"""Readers of the tables the operators work on: whole tables, columns pruned by what a query selects."""
