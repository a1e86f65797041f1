"""Part of tallyfeed."""
