"""End-to-end compositions and the catalogue of registered queries."""
