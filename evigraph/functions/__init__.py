"""Column functions: value normalizers and similarity measures."""
