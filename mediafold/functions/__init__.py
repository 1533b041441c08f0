"""Column functions: type detection, header dimensions, text shaping, metadata shaping, mel scale."""
