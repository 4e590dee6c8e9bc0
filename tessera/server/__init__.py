from tessera.server.server import Client, Server, Session
from tessera.server.wire import Request, Response, read_frame, write_frame

__all__ = ["Client", "Request", "Response", "Server", "Session", "read_frame", "write_frame"]
