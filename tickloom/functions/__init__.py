"""Column helpers shared by every operator."""
