"""Tables on shared storage, and readers of inputs."""
