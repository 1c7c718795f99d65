"""Reading pages and posts, extracting posts from pages, writing results."""
