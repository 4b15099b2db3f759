"""Detection on traces as they arrive. Windows, whitelists and pools are projections, and run on streams as they are."""
