"""Live inputs."""
