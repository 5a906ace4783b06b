"""Training-data operators: each module holds one operator and nothing outside this subpackage imports it."""
