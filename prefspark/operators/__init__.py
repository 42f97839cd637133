"""DataFrame operators: pure functions from tables to tables, lazy unless they say otherwise."""
