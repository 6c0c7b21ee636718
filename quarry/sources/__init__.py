"""Reading repositories: files, history, and what their texts declare."""
