"""Named queries over the star-schema tables, each with equivalent SQL."""
