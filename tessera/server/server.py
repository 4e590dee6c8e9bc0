"""A TCP query server: one engine, a thread and a session per connection."""

from __future__ import annotations

import itertools
import socket
import socketserver
import threading

from tessera.engine import Engine
from tessera.server.wire import MAX_FRAME, REQUEST, Request, Response, read_frame, write_frame
from tessera.shell.shell import Shell


class Session:
    """Answers payloads. A query that begins with a dot is a meta command and gives its text in one column."""

    def __init__(self, number: int, engine: Engine):
        self.id, self.engine, self.shell = number, engine, Shell(engine)

    def handle(self, payload: bytes) -> bytes:
        """An answer that no frame holds is an error of its own, and the session goes on."""
        answer = self._answer(payload)
        if len(answer) <= MAX_FRAME:
            return answer
        number = Response.decode(answer).id
        return Response(number, error=f"The result takes {len(answer):,} bytes and a frame holds {MAX_FRAME:,}: ask for fewer rows or columns").encode()

    def _answer(self, payload: bytes) -> bytes:
        try:
            request = Request.decode(payload)
        except ValueError as e:
            return Response(0, error=str(e)).encode()
        if request.kind != REQUEST:
            return Response(request.id, error="Unsupported request type").encode()
        if request.query.startswith("."):
            return Response(request.id, [("output", "VARCHAR")], [(self.shell.meta(request.query),)]).encode()
        r = self.engine.try_execute(request.query)
        if not r.success:
            return Response(request.id, error=r.error).encode()
        if r.kind == "message":
            return Response(request.id, [("output", "VARCHAR")], [(r.message,)]).encode()
        return Response(request.id, r.columns, r.rows).encode()


class Server:
    def __init__(self, engine: Engine, host: str = "127.0.0.1", port: int = 0):
        sessions, numbers, lock = {}, itertools.count(1), threading.Lock()

        class Handler(socketserver.BaseRequestHandler):
            def handle(self) -> None:
                with lock:
                    session = Session(next(numbers), engine)
                    sessions[session.id] = session
                try:
                    while (payload := read_frame(self.request)) is not None:
                        write_frame(self.request, session.handle(payload))
                except OSError:
                    pass  # the client is gone
                finally:
                    with lock:
                        sessions.pop(session.id, None)

        self.sessions = sessions
        self._server = socketserver.ThreadingTCPServer((host, port), Handler)
        self._server.daemon_threads = True
        self.address = self._server.server_address

    def start(self) -> Server:
        threading.Thread(target=self._server.serve_forever, daemon=True).start()
        return self

    def stop(self) -> None:
        self._server.shutdown()
        self._server.server_close()

    def __enter__(self) -> Server:
        return self.start()

    def __exit__(self, *_: object) -> None:
        self.stop()


class Client:
    def __init__(self, address: tuple[str, int]):
        self.socket, self.numbers = socket.create_connection(address), itertools.count(1)

    def query(self, text: str) -> Response:
        write_frame(self.socket, Request(next(self.numbers), text).encode())
        payload = read_frame(self.socket)
        if payload is None:
            raise ConnectionError("The server closed the connection")
        return Response.decode(payload)

    def close(self) -> None:
        self.socket.close()
