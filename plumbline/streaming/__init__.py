from .uploads import clean_stream, follow_uploads, write_uploads

__all__ = ["clean_stream", "follow_uploads", "write_uploads"]
