"""Reading and writing listings, pages and logs."""
