"""Search and corpus analytics as DataFrame jobs."""
