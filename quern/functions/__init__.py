"""Column functions: text rules, hashes, tokens, instruction variants."""
