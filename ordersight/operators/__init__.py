"""Row and table operators, each a function from DataFrame to DataFrame."""
