"""Reading, writing and searching data by URI."""
