"""Resolution of message histories, and reads of the result."""
