"""Where rows come from: images, envelopes, logs, queries, the vector collection."""
