"""Column functions and text-to-rows parsers."""
