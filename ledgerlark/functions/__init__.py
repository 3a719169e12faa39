"""Column functions: answer text to numbers, numbers to text, rendering."""
