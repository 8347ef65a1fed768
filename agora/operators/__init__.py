"""Relational jobs on domain tables. Every function maps DataFrames to a DataFrame, lazily."""
