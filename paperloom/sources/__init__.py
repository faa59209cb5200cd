"""Files as input: admission, page images, and text recognition."""
