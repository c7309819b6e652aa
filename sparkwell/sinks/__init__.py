"""Writers, order forms and instrument files."""
