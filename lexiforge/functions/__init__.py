"""Column builders: tokens, stems, URLs, pages."""
