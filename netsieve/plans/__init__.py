"""End-to-end plans built from the operators: derived test views, the
detection slice, training, log analysis."""
