"""Text operators for preparing training corpora."""
