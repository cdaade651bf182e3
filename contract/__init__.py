"""The query registry and its independent SQL answers."""
