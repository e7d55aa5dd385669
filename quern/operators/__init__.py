"""DataFrame operators: dedup, order and sampling, instructions, tokens, metrics."""
