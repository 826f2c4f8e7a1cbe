"""A package, so that its test files may share names with those one folder up."""
