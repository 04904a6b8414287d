"""leadloom subpackage."""
