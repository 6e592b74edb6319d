"""Column expressions: text, tokens, prompts, stemming."""
