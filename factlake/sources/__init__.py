"""Reading archives and tables; writing tables that only grow."""
