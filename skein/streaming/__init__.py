"""The engine has no streams: a graph is a batch of frames. Expiry, the only step that follows a
clock, is a filter (PropertyGraph.live)."""
