"""Relational operators over posts: one function per operator, DataFrame in, DataFrame out."""
