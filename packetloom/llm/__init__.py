"""Training-data operators over documents, pages and vectors; nothing else in the package imports them."""
