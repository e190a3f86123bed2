"""The find / path / show language: lexer, parser, and compiler to DataFrame plans."""
