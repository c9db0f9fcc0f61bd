"""A DataFrame-first engine for session logs, topic pages and text corpora."""
