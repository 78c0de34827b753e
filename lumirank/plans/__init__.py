"""Plan building blocks: scratch tables, ordered indexes, end-to-end jobs."""
