"""SOQL text -> syntax tree -> DataFrame plan."""
