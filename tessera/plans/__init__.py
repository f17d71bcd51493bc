"""Ready-made query plans over the sample schema."""
