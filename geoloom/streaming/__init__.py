"""Views of job events and request windows as streams."""
