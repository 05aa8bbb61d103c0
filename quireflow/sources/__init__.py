"""Tables in, positioned lines and words out."""
