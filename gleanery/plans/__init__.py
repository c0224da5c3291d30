"""Plans that several operators share, and the end-to-end jobs."""
