"""Tables from values and files, and back."""
