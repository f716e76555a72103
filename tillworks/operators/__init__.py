"""DataFrame -> DataFrame building blocks; none of them opens a session."""
