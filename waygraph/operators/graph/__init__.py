"""Analytics over plain edge tables ``src, dst[, w]``; undirected graphs hold each edge once."""
