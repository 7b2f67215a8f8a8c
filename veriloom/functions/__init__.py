"""Part of veriloom; see README.md."""
