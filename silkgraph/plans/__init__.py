"""Views, documented queries and the catalogue of registered queries."""
