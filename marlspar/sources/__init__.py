"""Where tables come from: paths, bytes, URLs; and what their footers say."""
