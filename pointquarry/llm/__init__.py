"""Corpus preparation operators: licences, mixing, near copies, search, archives,
toxicity, benchmark leaks, chat text, languages and repeated lines."""
