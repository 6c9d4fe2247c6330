"""Analytics over versioned, ordered key-value data, as DataFrame and SQL plans."""
