"""DataFrame-to-DataFrame transforms, one module per layer."""
