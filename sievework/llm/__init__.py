"""Training-data operators: each module states its contract; nothing outside this subpackage imports it."""
