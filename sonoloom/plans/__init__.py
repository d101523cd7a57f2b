"""Plan-shaping helpers shared by the operators."""
