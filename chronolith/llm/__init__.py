"""Training-data operators; nothing else in this library imports them."""
