"""Sources: file scans, decoding and parsers."""
