"""Reading source trees into tables and writing converted files out."""
