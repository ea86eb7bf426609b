"""Reading, guarding and compiling query plans."""
