"""The same operators over documents as they arrive."""
