"""Query plans: the catalogue of registered queries."""
