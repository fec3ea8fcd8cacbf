"""Part of noticeloom."""
