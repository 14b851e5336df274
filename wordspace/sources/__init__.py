"""Reading texts and keeping corpora and lexicons."""
