"""Set-oriented operators: a state DataFrame and a request DataFrame in, a new state or replies out."""
