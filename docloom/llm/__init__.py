"""Training-data operators; nothing else in docloom imports this subpackage."""
