"""Column functions: text, and everything else scalar."""
