"""Operators that prepare texts and conversations for model training; nothing else imports them."""
