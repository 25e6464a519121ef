"""Registered queries with their SQL, and the plan helpers the operators share."""
