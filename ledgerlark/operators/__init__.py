"""Relational operators: statements to contexts, contexts to questions, validation, sampling, audits, runs, scoring."""
