"""Column-to-Column functions: URLs, HTTP headers and status codes, text."""
